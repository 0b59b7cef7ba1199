"""Query plans: the boolean search language and its compiler."""
