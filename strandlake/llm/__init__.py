"""Training-data operators: packing, decontamination, quality, dedup, search, token files, chat, language, personal data.

Nothing outside this subpackage imports it.
"""
