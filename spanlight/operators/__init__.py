"""Relational operators over documents, sections, postings, candidates and packages."""
