"""Operators for preparing training data: scans, filters, deduplication, packing.

Each module holds one operator with a general DataFrame interface; ``queries``
applies them to the tables of a data folder.  Nothing outside this subpackage
imports it.
"""
