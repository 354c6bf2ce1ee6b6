"""quorumdf: operators."""
