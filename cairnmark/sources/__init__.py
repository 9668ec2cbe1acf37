"""Readers and writers of inventories, gold lists, markup lines and trip tables."""
