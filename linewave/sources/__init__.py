"""Images, scales and text outputs."""
