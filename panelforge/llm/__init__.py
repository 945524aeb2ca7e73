"""Operators that turn raw text into training data. Nothing outside this package imports it."""
