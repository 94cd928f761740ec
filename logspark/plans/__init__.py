"""Whole jobs: queries over stored events, profiles, onboarding."""
