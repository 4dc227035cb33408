"""Training-data operators: language ID, mixing, near-duplicates, licences, WARC,
decontamination, long-repeat removal, token files and sharding.

Nothing outside this package imports it.
"""
