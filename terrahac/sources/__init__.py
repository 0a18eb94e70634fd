"""How inputs become the canonical observation frame."""
