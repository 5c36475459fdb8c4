"""Relational operators of the retrieval engine: search, fusion, mining, paging and upkeep."""
