"""Training-data operators: quality, sharding, near-duplicates, language
modelling, licences, decontamination, toxicity, tokenisation, secrets, ranked
search and manifests.

Nothing outside this subpackage imports it.
"""
