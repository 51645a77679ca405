"""Training-data operators: near-dedup, language, toxicity, personal data, packing,
quality, tokenizers, exact search and web archives, each as Spark jobs."""
