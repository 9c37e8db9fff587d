"""Plans that several operators share: the rate card and its resolution."""
