"""Training-data operators: secrets, sharding, vector search, classifiers, near duplicates, decontamination, mixing, chat."""
