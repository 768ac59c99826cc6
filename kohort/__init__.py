"""kohort: a Spark-native engine that groups documents into cohorts (entities, events, near copies)."""
