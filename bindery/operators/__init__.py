"""DataFrame to DataFrame operators over `files`, `frames` and `manifest` rows.

Contract of the shared columns: `bundle` (string) is never null and `seq`
(long) is unique inside a bundle; `content` is BINARY.
"""
