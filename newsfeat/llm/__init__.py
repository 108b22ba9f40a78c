"""Operators of a training-data pipeline: fingerprints, weak supervision, line
and passage dedup, licence scans, SimHash, vector search, language spans,
curriculum mixing and byte-level BPE.  Nothing outside this subpackage imports
it; ``registry`` lists its queries."""
