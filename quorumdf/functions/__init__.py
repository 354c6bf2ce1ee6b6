"""quorumdf: functions."""
