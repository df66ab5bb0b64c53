"""Functions of the library; see the README."""
