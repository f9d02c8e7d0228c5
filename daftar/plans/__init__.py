"""Plans that join kernels and relational operators into whole jobs."""
