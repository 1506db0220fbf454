"""mnemospark: agent-memory analytics and retrieval expressed as Spark plans."""
