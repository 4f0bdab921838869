"""Writing corpora, sample datasets and splits."""
