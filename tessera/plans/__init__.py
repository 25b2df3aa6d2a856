"""Multi-step plans: the derived-column graph compiler and the automated regression fit."""
