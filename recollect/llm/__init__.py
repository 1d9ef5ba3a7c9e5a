"""Training-data operators: one module each, with the driver's queries in recollect.llm.queries."""
