"""Features, statistics and classifiers over pairs of texts, as DataFrame plans."""
