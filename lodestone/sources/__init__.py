"""Where snapshots come from: exports, plain tables, language files, settings."""
