"""strataq.reason"""
