"""DataFrame operators: models of the lakehouse and the upsert they share."""
