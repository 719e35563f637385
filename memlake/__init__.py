"""memlake: a PySpark-native analytics engine for long-lived knowledge stores."""
