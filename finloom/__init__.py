"""Corporate planning and consolidation jobs expressed as Spark DataFrame plans."""
