"""DataFrame operators over a change log (key, commit_ts, value or NULL)."""
