"""Readers, writers, file inventories and ledgers."""
