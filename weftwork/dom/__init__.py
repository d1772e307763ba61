"""Document trees and selectors, for the functions that need markup."""
