"""Jobs composed of the operators: consolidation, reconciliation, period close and reports."""
