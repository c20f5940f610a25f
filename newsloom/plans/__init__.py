"""Multi-step plans: rules, relevance, duplicates, classification, the source registry, the warehouse."""
