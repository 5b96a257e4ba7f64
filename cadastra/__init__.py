"""cadastra: a Spark-native engine for declaration documents and the records made from them."""
