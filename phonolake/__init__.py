"""Phonolake: phonetic text corpora, vocabularies, pair data sets and scores on Spark."""
