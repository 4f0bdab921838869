"""Reading corpora, packed datasets, stream catalogues and tokeniser files."""
