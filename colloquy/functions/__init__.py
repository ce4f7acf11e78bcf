"""Part of colloquy; see the README for the layout."""
