"""Operators over corpora of documents, blocks, sentences and sections."""
