"""Operators beyond plain DataFrame methods: guarded joins, temporal folds, graphs, mapping, vectors, training data."""
