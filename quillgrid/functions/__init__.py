"""Part of the quillgrid package."""
