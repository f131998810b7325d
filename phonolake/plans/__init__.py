"""Composite jobs: each is one lazy plan unless its docstring says otherwise."""
