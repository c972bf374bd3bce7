"""Training-data operators: language ID, quality rules, fixity, BPE, secrets, near duplicates, URL rules,
decontamination, HTML extraction and line deduplication. Nothing else in the library imports this subpackage."""
