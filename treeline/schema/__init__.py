"""Schema compilation: types, the relational model and its compiler."""
