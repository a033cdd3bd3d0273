"""Structured Streaming jobs (S4, ST1-ST4).  Every query is checkpointed in the
shared checkpoint folder, so a restarted job resumes without loss or repeats."""
