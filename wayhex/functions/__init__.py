"""Part of wayhex."""
