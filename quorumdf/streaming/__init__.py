"""quorumdf: streaming."""
