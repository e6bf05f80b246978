"""Structured Streaming versions of the stateful rules.

Rules whose next state depends on their own last decision (limits that count
only what they accepted, windows anchored at their first event, a session that
stays revoked) can't be window functions.  Each is one fold over a key's events
in order of time, used for batches by ``applyInPandas`` and for streams by
``transformWithStateInPandas``, so both give the same answers.
"""
