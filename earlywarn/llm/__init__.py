"""Operators for large-scale training-data pipelines (language ID, sharding,
line and near-duplicate removal, PII, packing, vector search, token files,
source mixing).  Nothing outside this subpackage imports it."""
