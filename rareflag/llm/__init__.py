"""Training-data pipeline operators (near-dedup, licence scans, quality rules, chat
formatting, HTML extraction, BPE, decontamination, token counts, language ID,
quality classifier). Nothing outside this subpackage imports it."""
