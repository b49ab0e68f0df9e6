"""Landed exchange documents and stored quote files as DataFrames.

A document table has the columns of ``schemas.RAW_PAYLOADS``. Every reader
parses with native expressions and explodes documents to rows.
"""
