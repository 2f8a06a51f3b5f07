"""A PySpark-native engine for agent-trajectory analytics and training-data preparation."""
