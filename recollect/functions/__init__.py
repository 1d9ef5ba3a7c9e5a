"""Part of recollect; see the README for the layout."""
