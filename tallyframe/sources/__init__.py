"""Readers and writers: photos, manifests, run logs, verdicts, the model catalogue."""
