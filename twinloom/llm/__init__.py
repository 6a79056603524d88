"""Training-data operators: language, tokens, duplicates, quality, scoring, pages, mixing."""
