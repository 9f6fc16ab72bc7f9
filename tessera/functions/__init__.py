"""Column functions: exact money, durations, dates, text keys, redaction and hashes. No user functions."""
