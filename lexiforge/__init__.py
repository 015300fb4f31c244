"""Lexicon analytics on Spark: spelling, morphology, suggestions and transliteration over tables and streams of words."""
