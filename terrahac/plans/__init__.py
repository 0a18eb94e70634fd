"""Parameters of an estimate, and the fits that come before it."""
