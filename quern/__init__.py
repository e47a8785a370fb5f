"""Program analysis of build scripts as DataFrame operators, usable on ordinary tables."""
