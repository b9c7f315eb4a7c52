"""Operators that prepare text corpora for language-model training; nothing outside this folder imports them."""
