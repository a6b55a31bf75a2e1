"""Training-data operators: sharding, packing, language ID, nearest neighbours, secret scans,
decontamination, URL filters, language-model scoring, token output and near-duplicates.

Nothing outside this subpackage imports it.
"""
