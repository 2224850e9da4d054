"""paralens: PySpark-native analytics for prompt-wording sensitivity studies."""
