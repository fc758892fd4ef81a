"""Part of weftline; see the README for the map of modules."""
