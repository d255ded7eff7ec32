"""Event-centred analytics on time-stamped tables, expressed as Spark DataFrame operators."""
