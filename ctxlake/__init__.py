"""PySpark-native search and analysis of text, code graphs and event logs."""
