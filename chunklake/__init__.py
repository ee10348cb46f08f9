"""chunklake: storage, registry, accounting and corpus analytics expressed as Spark plans."""
