"""Scalar functions as pure Column builders; nothing here runs Python on rows."""
