"""Land-change detection and asset-risk analytics as Spark DataFrame operators."""
