"""kvlattice: a Spark-first engine for versioned key-value data.

Logs of ``(user_key, version, value, meta, user_meta, expires_at)`` rows are
DataFrames; scans, seeks, as-of reads, merges, manifests, value logs, garbage
collection and log replay are DataFrame plans over them.
"""
