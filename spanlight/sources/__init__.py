"""Folders, parsers and adapters that become document tables."""
