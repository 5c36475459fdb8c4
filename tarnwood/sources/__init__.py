"""Readers of files: markdown vaults, session archives, configuration, logs."""
