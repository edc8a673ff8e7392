"""Extraction profiles: which files, which markers, which expressions. Folders of YAML files in the same form add to these."""
