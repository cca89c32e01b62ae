"""Row, column, lookup, aggregation and set operators: functions from DataFrame to DataFrame."""
