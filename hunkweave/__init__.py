"""Spark-native commit untangling and the relational pieces it is made of."""
