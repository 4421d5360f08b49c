"""sparrowmill: a PySpark-native relational analytics engine."""
