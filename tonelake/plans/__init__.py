"""Session plans: their validation, stimulus layout and localization."""
