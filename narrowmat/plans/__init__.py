"""Multi-stage reduction of row blocks across partitions."""
