"""DataFrame operators of the planning model."""
