"""pulsemill: a Spark-native sensor lakehouse and analytics engine."""
