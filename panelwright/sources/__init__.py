"""panelwright.sources"""
