"""Declarations (views, features, targets, schedules) and their compilation to DataFrame plans."""
