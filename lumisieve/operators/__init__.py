"""Hashing, dihedral variants and matching as DataFrame transforms."""
